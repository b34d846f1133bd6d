"""Readers that turn files and tables into document DataFrames."""
