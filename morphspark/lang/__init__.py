"""The rule and expression language: lexer, parser and syntax tree."""
