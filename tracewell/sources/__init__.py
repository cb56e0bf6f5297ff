"""Where documents come from and where cases are kept: discovery, loaders, the case store."""
