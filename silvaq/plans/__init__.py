"""Pattern language: syntax tree, parser and compilers to Spark plans."""
