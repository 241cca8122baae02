"""Query text to DataFrame plan: lexer, parser, rewriter, lowering."""
