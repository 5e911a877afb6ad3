"""DataFrame -> DataFrame operators over the posting tables."""
