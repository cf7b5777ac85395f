"""Pages put together from operators, and the binding to the driver's tables."""
