"""basalt: analytics over versioned key-value change logs, written as DataFrame operators."""
