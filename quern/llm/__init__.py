"""Operators that prepare large text and code corpora for training. Nothing else imports this package."""
