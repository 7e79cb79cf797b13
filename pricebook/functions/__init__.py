"""Column-building functions: text, doses, amounts, attributes, prices, stock and URLs."""
