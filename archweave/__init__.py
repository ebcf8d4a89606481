"""archweave: Spark jobs for architecture governance over fleets of repositories and event topics."""
