"""Sources (readers), sinks (writers) and derived test inputs."""
