"""Operators for building language-model training data; nothing else in typelens imports them."""
