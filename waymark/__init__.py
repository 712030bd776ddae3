"""Trajectory, graph and corpus analytics as PySpark DataFrame operators."""
