"""Bundled grammars, one text file for each language.

Notation: ``name: alternative | alternative``, continued on indented lines.
Quoted words and upper-case names are terminals, lower-case names rules,
``( )`` groups; ``?``, ``*`` and ``+`` follow what they repeat and ``X~`` is a
comma-separated list of at least one X. ``#`` starts a comment. Precedence is
left out: only membership in the language is decided.
"""
