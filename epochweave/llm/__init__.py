"""Operators for preparing the text that a language model is trained on."""
