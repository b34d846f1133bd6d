"""Type inference, relational plans and their renderings; driver-side work on profiles of bounded size."""
