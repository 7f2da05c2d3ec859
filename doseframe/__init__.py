"""Perturbation-response analytics as Spark DataFrame operators.

Every operator is a function from DataFrames and parameters to a DataFrame.
Nothing is collected inside an operator and no operator keeps session state.
"""
