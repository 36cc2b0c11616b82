"""Quality analytics for document corpora on Spark.

functions: Column helpers; operators: DataFrame -> DataFrame; sources: readers and writers; streaming: stateful
operators; plans: named queries over the tables of a data folder, with the SQL that gives the same rows.
"""
