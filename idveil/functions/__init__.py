"""Column functions: text normalisation, checksums, recognizers, context, tokens."""
