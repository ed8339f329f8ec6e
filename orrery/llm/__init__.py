"""Operators of a training-data pipeline: ten, one module each.

Nothing outside this folder imports it. Workers import it: session.prepare
sends it to them, so that they need not have the repository on their path.
"""
