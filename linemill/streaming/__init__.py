"""Line operators and contracts on Structured Streaming frames."""
