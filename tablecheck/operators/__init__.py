"""DataFrame operators: rules, frequencies, quantiles, samples, schema comparison."""
