"""Reading and writing: typed loads, exports, bindings to the test tables."""
