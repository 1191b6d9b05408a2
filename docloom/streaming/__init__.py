"""Change events: debounce, coalescing, incremental apply."""
