"""DataFrame -> DataFrame operators. No actions, no loops over rows, no current time inside."""
