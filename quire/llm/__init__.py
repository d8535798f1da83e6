"""Training-data operators: each module holds one operator over DataFrames.

``queries`` registers one thin query for each of them. Nothing outside this
subpackage imports it.
"""
