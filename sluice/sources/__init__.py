"""Report readers: a table of raw reports in, typed fact tables and a gaps table out."""
