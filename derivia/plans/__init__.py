"""How a session runs the library: code shipping and run contexts."""
