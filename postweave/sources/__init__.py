"""From captured payloads to the canonical posting table."""
