"""Operators for preparing training data. Nothing else in the library imports this package.

Texts are handled where they lie: every Python part runs inside ``mapInArrow`` on blocks of bounded size, Spark does all
grouping, joining and spreading. The functions of this package travel with the job, so executors need no installed copy.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
