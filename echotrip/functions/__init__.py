"""Column builders: text clean-up, tokenisation, n-gram statistics, score formulas."""
