"""Training-data operators: one module per operator, queries in ``queries``.

Nothing else in the library imports this subpackage. Its functions travel to Python
workers with the tasks.
"""

from ..session import ship_python_code

ship_python_code()
