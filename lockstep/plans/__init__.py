"""What is compared with what."""
