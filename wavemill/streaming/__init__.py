"""The stateless and tumbling operators on streams."""
