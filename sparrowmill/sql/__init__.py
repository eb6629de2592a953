"""The SQL dialect: lexer, parser, syntax tree and binder."""
