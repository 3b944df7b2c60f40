"""The motion controller's commands."""

from __future__ import annotations

# Opcode, name, value type when sent, value type when returned.
COMMANDS = """
0x0106 MOT_GetMotorCurrent none f32
0x0107 MOT_GetMotorVoltage none f32
0x0108 MOT_GetMotorPosition none f32
0x0109 MOT_GetLoadPosition none f32
0x010A MOT_GetMotorSpeed none f32
0x0101 MOT_MerRegister none u16
0x0102 MOT_DerRegister none u16
0x0103 MOT_SrhRegister none u16
0x0104 MOT_SrlRegister none u16
0x0105 MOT_MsrRegister none u16
0x010C MOT_GetNegSWLS none f32
0x010D MOT_GetPosSWLS none f32
0x0110 MOT_IsActiveSWLS none u8
0x014F MOT_GetShortPath none u8
0x012E MOT_GetMaxCurrent none f32
0x0130 MOT_SetAcceleration f32 none
0x0131 MOT_SetSpeed f32 none
0x0132 MOT_SendPosition f32 none
0x0133 MOT_SetActualPosition f32 none
0x0134 MOT_Update none none
0x0135 MOT_Homing none none
0x0136 MOT_SetNegSWLS f32 none
0x0137 MOT_SetPosSWLS f32 none
0x0146 MOT_ActivateSWLS u8 none
0x0138 MOT_SetPositionRelative f32 none
0x0139 MOT_SetPositionAbsolute f32 none
0x013A MOT_SetSpeedMode none none
0x013B MOT_SetPositionMode none none
0x013C MOT_AxisOn none none
0x013D MOT_AxisOff none none
0x013E MOT_AxisReset none none
0x013F MOT_SetTum u8 none
0x0143 MOT_ResetFaults none none
0x014E MOT_SetShortPath u8 none
0x0165 MOT_SaveMotorSetting none none
0x0166 MOT_SetMaxCurrent f32 none
0x0144 MOT_SetMotionComplete none none
0x0400 SCN_SetYawMin f32 none
0x0401 SCN_SetYawMax f32 none
0x0402 SCN_SetPitchMin f32 none
0x0403 SCN_SetNumSteps u32 none
0x0404 SCN_SetStepHeight f32 none
0x0405 SCN_SetScanSpeed f32 none
0x0406 SCN_SetShortPath u8 none
0x0407 SCN_IsScanOn none u8
0x0408 SCN_StopScan none none
0x040C SCN_StartScanZigZag none none
0x040D SCN_StartScanSnake none none
0x040E SCN_StartScanSquare none none
0x0700 COM_Reboot none none
0x0702 COM_Connect none none
0x0703 COM_Disconnect none none
0x0704 COM_IsConnected none u8
0x0705 COM_StartKeepAlive none none
0x0706 COM_IsKeepAliveOn none u8
0x0708 COM_setKeepAliveTimeout u32 none
0x0709 COM_getKeepAliveTimeout none u32
0x071C COM_setKeepAliveCount u32 none
0x071D COM_getKeepAliveCount none u32
0x0719 COM_SetComType u8 none
0x0713 COM_SysState none u8
0x070A IP_SetControllerIP u32 none
0x070D IP_GetControllerIP none u32
0x070B IP_SetControllerPort u16 none
0x070E IP_GetControllerPort none u16
0x071A IP_SetControllerSubnetMask u32 none
0x0710 IP_SaveIP none none
0x0C2D COM_GetPn none u32
0x0C2F COM_GetSn none u32
0x0C4A COM_GetFw none u32
0x0C4C COM_GetHw none u32
0x0300 LRF_SetRange f32 none
0x0301 LRF_GetRange none f32
0x0800 STB_StabilizationOn none none
0x0801 STB_StabilizationOff none none
0x0822 STB_GetStabError none f32
0x0839 STB_SetStabMinAccel f32 none
0x083A STB_GetStabMinAccel none f32
0x0D04 STB_SetSpdKp f32 none
0x0D08 STB_GetSpdKp none f32
0x0D05 STB_SetSpdKi f32 none
0x0D09 STB_GetSpdKi none f32
0x0D06 STB_SetSpdKd f32 none
0x0D0A STB_GetSpdKd none f32
0x0D16 STB_SetPosKp f32 none
0x0D17 STB_GetPosKp none f32
0x0D18 STB_SetPosKi f32 none
0x0D19 STB_GetPosKi none f32
0x0D1A STB_SetPosKd f32 none
0x0D1B STB_GetPosKd none f32
0x082B STB_SetDistanceToTarget f32 none
0x082A STB_GetDistanceToTarget none f32
0x0825 STB_SetCentralAxes u8 none
0x0826 STB_GetCentralAxes none u8
0x0C76 STB_SetRollCompensation u8 none
0x0C77 STB_GetRollCompensation none u8
0x084F STB_SetRebalanceOn none none
0x0850 STB_GetRebalanceOn none u8
0x0851 STB_GetRebalanceStatus none u8
0x0D07 STB_SaveStabilizationCfg none none
0x0FA0 DG_SetSyncMode u8 none
0x0FA1 DG_SetInnerMode u8 none
0x0FA2 DG_IsSyncMode none u8
0x0FA3 DG_IsInnerMode none u8
0x0FA5 DG_GetPosDiff none f32
0x0FA6 DG_SetMaxDiff f32 none
0x0FA7 DG_GetMaxDiff none f32
0x0FA9 DG_GoToCamera u8 none
0x0FAA DG_SetSyncSpd f32 none
0x0FAB DG_SetMainGimbal u8 none
0x0FAC DG_GetMainGimbal none u8
0x0FB0 DG_CTC none none
0x0FB1 DG_GetCTCoffset none f32
0x0FB2 DG_ResetCTCoffset none none
0x0FB5 DG_GetSyncSpd none f32
0x0FB6 DG_SetActiveWeapon u8 none
0x0FB7 DG_GetActiveWeapon none u8
0x0FB9 DG_IsBoresightEn none u8
0x0FBA DG_SetActiveCamera u8 none
0x0FBB DG_GetActiveCamera none u8
0x0FBC DG_GetBoresightOffset none f32
0x0FBD DG_SetBallisticOffset f32 none
0x0FBE DG_GetBallisticOffset none f32
0x0FBF DG_GetSafetyStatus none u8
0x0FC0 DG_GetLoadStatus none u8
0x0FC1 DG_GetCapsnapIOStatus none u16
0x0FC2 DG_GetNumBullets none u16
0x0FC3 DG_ResetNumBullets none none
0x0FC4 DG_IsCapSnapReady none u8
0x0E01 ERR_CaptureSystemRegister none u32
0x0E02 ERR_ClearErrors none none
0x0E03 ERR_GetDriverErrorString none none
0x0E04 ERR_GetSystemErrorString none none
0x0E05 ERR_GetLoadImuErrorString none none
0x0E06 ERR_GetBaseImuErrorString none none
0x0E07 ERR_GetGpsComErrorString none none
0x0E08 ERR_GetGpsPosString none none
0x0E09 ERR_GetGpsHeadErrorString none none
0x0E0A ERR_GetProtocolErrorString none none
0x0E0D ERR_GetAbsEncComErrorString none none
0x0E0E ERR_GetAbsEncCRCErrorString none none
0x0E0F ERR_GetBodyImuErrorString none none
0x0E10 ERR_GetHomingErrorString none none
0x0E12 ERR_OperationRegister none u16
"""

OPCODES = [(int(code, 16), name, sent, returned)
           for code, name, sent, returned in (line.split() for line in COMMANDS.strip().splitlines())]
