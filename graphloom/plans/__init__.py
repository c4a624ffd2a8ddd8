"""Plans that combine operators: call resolution and the build."""
