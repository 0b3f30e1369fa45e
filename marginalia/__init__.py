"""Part of marginalia, a Spark-native analytics engine for collections of notes and documents."""
