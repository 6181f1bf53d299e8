"""Fuel-telemetry denoising and analytics as Spark plans, and operators for training data in tankwise.llm."""
