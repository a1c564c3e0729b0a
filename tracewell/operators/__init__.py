"""Schema-parameterised DataFrame operators."""
