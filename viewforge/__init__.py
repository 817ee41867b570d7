"""viewforge: a PySpark-native data-preparation and evaluation engine for contrastive code and text corpora."""
