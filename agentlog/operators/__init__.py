"""DataFrame operators over normalized agent logs."""
