"""DataFrame operators over spans and traces."""
