"""tablescope: table cleaning, profiling and report checks as Spark batch jobs."""
