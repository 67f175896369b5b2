"""threadlens: conversation risk analytics and corpus mining as Spark DataFrame operators."""
