"""DataFrame operators on word, interval and frame sequences."""
