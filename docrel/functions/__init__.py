"""Column functions: text measures and cleaning, classification of VARIANT values, coercion to target types."""
