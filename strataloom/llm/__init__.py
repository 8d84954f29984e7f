"""Operators for preparing training corpora.

Thirteen operators, each in its own module.  Nothing outside this folder imports it;
the entry file adds its queries only when it can be imported.
"""
