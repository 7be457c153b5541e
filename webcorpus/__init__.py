"""webcorpus: web-page and search-result analytics as Spark DataFrame operators.

Sub-packages:

* ``functions`` -- ``Column -> Column`` building blocks (text cleaning, URLs, HTML
  slicing, contacts, labels). All of them are native Spark expressions.
* ``operators`` -- ``DataFrame -> DataFrame`` operators (fallback, merge, crawl,
  keyword search, service reports).
* ``sources`` -- table loaders, derived fixture views and provider-JSON readers.
* ``streaming`` -- Structured Streaming forms of the operators.
* ``plans`` -- the named query catalogue used by ``__spark_entry__`` and ``bench.py``.
"""

__version__ = "0.1.0"
