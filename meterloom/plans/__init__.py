"""The catalogue of registered queries and their oracle SQL."""
