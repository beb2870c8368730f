"""Edit sources: fixture recipe, stream/batch readers, the JSON decode."""
