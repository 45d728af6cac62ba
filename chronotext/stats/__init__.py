"""Statistics of small panels in numpy; distributed over specifications, folds and permutations, not over rows."""
