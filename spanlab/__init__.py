"""spanlab: the data side of text-to-text labelling and span extraction on Spark.

Every operator takes and returns ``pyspark.sql.DataFrame``; nothing is collected
to the driver. Sub-packages:

- ``spanlab.sources``   readers and writers (TSV, CSV, JSON config, run folders)
- ``spanlab.functions`` column expressions (cleaning, prompts, similarity, seeded keys)
- ``spanlab.operators`` table operators (joins, votes, span matching, scores,
  balancing, augmentation, error analysis, prediction, checkpoint choice)
- ``spanlab.plans``     end-to-end compositions and the driver-table mapping
- ``spanlab.streaming`` stateless operators applied to streaming DataFrames
"""

__version__ = "0.1.0"
