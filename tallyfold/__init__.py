"""Portfolio and company analysis as plain DataFrame functions."""
