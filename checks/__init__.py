"""Every operator over the shared test tables, each with an equivalent SQL text where one exists."""
