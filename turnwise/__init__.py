"""turnwise: Spark-native analytics over time-aligned transcripts, speaker turns and speaker embeddings."""
