"""Column builders (``text``), row kernels (``kernels``) and their Arrow wrappers (``arrow``)."""
