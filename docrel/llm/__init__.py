"""Training-data operators (substring dedup, search, LM scoring, secrets, near copies, mixing, decontamination,
sharding, quality, token files, token alignment, chat formatting, prefix tries). Nothing outside this subpackage imports it."""
