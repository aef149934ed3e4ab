"""Planning: headers and shapes, profile, blueprint, and the pipeline that carries a blueprint out."""
