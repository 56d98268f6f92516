"""Tables the flow reads and writes."""
