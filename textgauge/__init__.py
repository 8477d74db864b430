"""Text-fidelity and checklist evaluation on Spark."""
