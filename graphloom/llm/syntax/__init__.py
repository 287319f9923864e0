"""Syntax checks of single files: lexer-state maps, bracket summaries, local grammars."""
