"""Operators for preparing language-model training text at corpus scale.

Nothing outside this folder imports it; the registry in ``queries`` is picked up
by ``__spark_entry__`` when the folder is present.
"""
