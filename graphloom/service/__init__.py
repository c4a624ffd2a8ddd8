"""Command line and JSON-RPC service."""
