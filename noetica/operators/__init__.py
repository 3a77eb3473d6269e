"""DataFrame operators over graphs, episodes, searches, communities and threads."""
