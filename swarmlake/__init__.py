"""swarmlake: a PySpark-native analytics engine for torrent-metadata catalogs."""
