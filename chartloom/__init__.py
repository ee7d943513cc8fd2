"""Clinical document analytics as Spark DataFrame jobs.

Every operator is a ``DataFrame -> DataFrame`` function over whole tables; see
``operators`` for the building blocks, ``plans`` for composed jobs and the
registered queries, ``streaming`` for the job log and ``sources`` for intake
and export.
"""
