"""casegrid: a PySpark-native engine for coded case reports and text corpora."""
