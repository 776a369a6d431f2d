"""tempora: a PySpark-native engine for historical grids, keyframe stores and event logs."""
