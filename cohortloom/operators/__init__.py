"""DataFrame to DataFrame operators; columns are named by parameters."""
