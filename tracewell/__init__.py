"""Spark-native analytics over multi-channel waveform data sets."""
