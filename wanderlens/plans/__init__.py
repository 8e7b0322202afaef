"""Reports: operators put together over one set of inputs."""
