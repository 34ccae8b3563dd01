"""DataFrame operators for timelines, transcripts and event counters on Spark."""
