"""moodspark: emotion-text analytics as Spark DataFrame jobs.

Every public function takes DataFrames (or a SparkSession plus paths) and
returns a lazy DataFrame; nothing is collected to the driver except
size-checked, bounded side tables.
"""

__version__ = "0.1.0"
