"""Jobs composed from the operators: transforms, panel, quality, rules, search."""
