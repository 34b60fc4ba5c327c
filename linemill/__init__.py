"""Line-stream analytics and data contracts on Spark DataFrames."""
