"""lumenframe: data-quality checks and exploratory analysis as Spark DataFrame operators."""

from pyspark import cloudpickle

from .functions import special as _special
from .sources import workbook as _workbook

# The numeric helpers travel with the task, so executors need no copy of the package on their path.
cloudpickle.register_pickle_by_value(_special)
cloudpickle.register_pickle_by_value(_workbook)
