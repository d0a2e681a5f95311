"""Text functions: Column expressions and the Python kernel behind document stages."""
