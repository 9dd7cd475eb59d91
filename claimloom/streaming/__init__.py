"""The one incremental behaviour: captures are durable at once and can be finalised later, or twice."""
