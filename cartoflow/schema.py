"""Canonical table layouts.  Every operator takes and returns DataFrames with (some of) these columns."""

POSE = "tx double, ty double, tz double, qx double, qy double, qz double, qw double"
POINTS = "session_id int, submap_id int, frame_id long, pt_idx int, stamp double, t double, x double, y double, z double, intensity double, ring int, rgba struct<r:double,g:double,b:double,a:double>, range float, gps_time double, scanner_id float"
KNN = "frame_id long, i long, rank int, j long, d2 double"
FRAMES = f"frame_id long, stamp double, frame_tag string, T_world_lidar struct<{POSE.replace(' ', ':').replace(',:', ',')}>, v array<double>, bias array<double>, imu_traj array<struct<t:double,tx:double,ty:double,tz:double,qx:double,qy:double,qz:double,qw:double>>"
SUBMAPS = "session_id int, submap_id int, " + POSE + ", num_frames int"
FACTORS = "factor_id long, batch_id int, type string, level int, k1_chr string, k1_idx int, k2_chr string, k2_idx int, measured array<double>, sigma array<double>"
GRAPH_VALUES = "chr string, idx int, value array<double>"
IMU = "stamp double, ax double, ay double, az double, wx double, wy double, wz double"
GNSS = "stamp double, lat double, lon double, alt double, status int, s_e double, s_n double, s_u double"
TRAJECTORY = "session_id int, frame_id long, stamp double, " + POSE + ", cumulative_dist double"
MATCHES = "u_real double, v_real double, u_rend double, v_rend double, score float"
GEOID = "table string, lat double, lon double, n double"
CHUNKS = "chunk_id int, cx double, cy double, cz double, fx double, fy double, half_size double, half_height double"
