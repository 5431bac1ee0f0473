"""Training-data operators: thirteen corpus operators, each a DataFrame program.

Nothing outside this folder imports it; ``__spark_entry__.py`` adds its queries when it is present.
"""
