"""Operators over fact tables, parameterised by column names."""
