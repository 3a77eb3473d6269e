"""noetica: a PySpark-native engine for personal knowledge graphs and the text corpora behind them."""
