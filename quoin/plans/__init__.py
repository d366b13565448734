"""Rule sets and reports composed of operators."""
